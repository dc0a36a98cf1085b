"""Query specifications: named operations over named layers, lowered to lazy DataFrames."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import aggregates, attributes, buffers, network, overlay, proximity, raster, scoring, shapes, spatial, voronoi
from ..sources import files, sinks


@dataclass(frozen=True)
class Operation:
    """One step: its name, the operation, the layers it takes (by role; a role may take several) and its parameters."""

    name: str
    op: str
    inputs: dict[str, str | list[str]]
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class QuerySpec:
    operations: tuple[Operation, ...]
    output: str


#: Operations by public name: the function and the roles of its layers, in order of its arguments.
OPERATIONS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "filter_attribute": (attributes.filter_features, ("vector",)),
    "sort_limit": (attributes.filter_features, ("vector",)),
    "calculate_field": (attributes.calculate_field, ("vector",)),
    "map_schema": (attributes.map_schema, ("vector",)),
    "normalize_persian_text": (attributes.normalize_persian_text, ("vector",)),
    "enrich_feature_properties": (attributes.enrich_properties, ("vector",)),
    "enrich_risk": (attributes.enrich_risk, ("vector",)),
    "join_feature_properties": (attributes.join_properties, ("left", "right")),
    "deduplicate": (attributes.deduplicate, ("vector",)),
    "sample": (attributes.sample_features, ("vector",)),
    "outliers": (attributes.detect_outliers, ("vector",)),
    "classify": (attributes.classify_breaks, ("vector",)),
    "aggregate_table": (aggregates.aggregate_table, ("vector",)),
    "attribute_statistics": (aggregates.attribute_statistics, ("vector",)),
    "build_chart": (aggregates.chart_data, ("vector",)),
    "rank_features": (scoring.rank_features, ("vector",)),
    "top_n": (scoring.rank_features, ("vector",)),
    "score_features": (scoring.score_features, ("vector",)),
    "topsis": (scoring.rank_topsis, ("vector",)),
    "real_estate_score": (scoring.score_properties, ("vector",)),
    "filter_points_in_polygon": (spatial.filter_points_in_polygon, ("vector", "polygon")),
    "spatial_join": (proximity.spatial_join, ("source", "target")),
    "spatial_nearest": (proximity.nearest_neighbors, ("source", "target")),
    "nearest_neighbor": (proximity.nearest_neighbors, ("source", "target")),
    "filter_by_distance": (proximity.nearest_neighbors, ("vector", "reference")),
    "distance_to": (proximity.distances, ("vector", "target")),
    "connect_nearest_lines": (spatial.connection_lines, ("vector",)),
    "aggregate_points": (spatial.aggregate_points, ("points", "polygons")),
    "clip": (overlay.clip_by, ("vector", "mask")),
    "erase": (overlay.erase, ("vector", "erase")),
    "union": (overlay.union, ("source", "target")),
    "intersect": (overlay.intersect_filter, ("source", "target")),
    "dissolve": (overlay.dissolve, ("vector",)),
    "hotspots": (spatial.hotspots, ("vector",)),
    "spatial_autocorrelation": (spatial.morans_i, ("vector",)),
    "kernel_density": (spatial.kernel_density, ("points",)),
    "idw": (spatial.interpolate_idw, ("points",)),
    "cluster": (spatial.cluster, ("vector",)),
    "generate_grid": (shapes.grid_over, ("vector",)),
    "real_estate_spatial_enrich": (proximity.enrich_real_estate, ("vector",)),
    "load_csv": (files.load_csv, ()),
    "export_table": (sinks.table_columns, ("vector",)),
    "export_geojson": (sinks.geojson_rows, ("vector",)),
    "crs_transform": (shapes.transform_crs, ("vector",)),
    "buffer": (buffers.buffer, ("vector",)),
    "ring_buffer": (buffers.ring_buffers, ("vector",)),
    "centroids": (shapes.centroids, ("vector",)),
    "area_perimeter": (shapes.area_perimeter, ("vector",)),
    "simplify": (shapes.simplify, ("vector",)),
    "explode": (shapes.explode_multipart, ("vector",)),
    "convex_hull": (shapes.convex_hull, ("vector",)),
    "voronoi": (voronoi.voronoi, ("points",)),
    "validate_geometries": (shapes.validate, ("vector",)),
    "repair_geometries": (overlay.repair, ("vector",)),
    "check_topology": (overlay.check_topology, ("vector",)),
    "ndvi": (raster.ndvi, ("raster",)),
    "calculate_ndvi": (raster.ndvi, ("raster",)),
    "ndvi_from_bands": (raster.ndvi_from_bands, ("red_band", "nir_band")),
    "spectral_index": (raster.spectral_index, ("raster",)),
    "band_math": (raster.band_math, ("raster",)),
    "raster_threshold": (raster.threshold, ("raster",)),
    "raster_reclassify": (raster.reclassify, ("raster",)),
    "raster_clip": (raster.clip_raster, ("raster",)),
    "mosaic": (raster.mosaic, ("rasters",)),
    "weighted_overlay": (raster.weighted_overlay, ("rasters",)),
    "slope_aspect": (raster.slope_aspect, ("raster",)),
    "reproject_raster": (raster.reproject_raster, ("raster",)),
    "hillshade": (raster.hillshade, ("raster",)),
    "focal_statistics": (raster.focal_statistics, ("raster",)),
    "raster_change": (raster.raster_change, ("before", "after")),
    "contours": (raster.contour_lines, ("raster",)),
    "raster_to_points": (raster.raster_to_points, ("raster",)),
    "raster_to_vector": (raster.raster_polygons, ("raster",)),
    "raster_stats": (raster.raster_statistics, ("raster",)),
    "zonal_statistics": (raster.zonal_statistics, ("raster", "zones")),
    "sample_raster": (raster.sample_raster, ("raster", "points")),
    "shortest_path": (network.shortest_path, ("network",)),
    "service_area": (network.service_area, ("network", "origins")),
    "od_matrix": (network.od_matrix, ("network", "origins", "destinations")),
    "accessibility_2sfca": (network.accessibility_2sfca, ("network", "supply", "demand")),
}


class SpecError(ValueError):
    """The specification can't be run."""


def validate(spec: QuerySpec, layers: set[str]) -> None:
    """Operations are known, named once, and take layers that exist by then and parameters that they have."""
    known = set(layers)
    for step in spec.operations:
        if step.op not in OPERATIONS:
            raise SpecError(f"unknown operation {step.op}")
        if step.name in known:
            raise SpecError(f"{step.name} is used twice")
        if missing := [r for r in OPERATIONS[step.op][1] if r not in step.inputs]:
            raise SpecError(f"{step.name} lacks {', '.join(missing)}")
        taken = [x for v in step.inputs.values() for x in ([v] if isinstance(v, str) else v)]
        if unknown := [x for x in taken if x not in known]:
            raise SpecError(f"{step.name} takes unknown layers {', '.join(unknown)}")
        function, roles = OPERATIONS[step.op]
        accepted = list(inspect.signature(function).parameters.values())[len(roles) :]
        strange = (set(step.params) | set(step.inputs) - set(roles)) - {p.name for p in accepted}
        if strange and not any(p.kind is p.VAR_KEYWORD for p in accepted):
            raise SpecError(f"{step.name} has no parameter {', '.join(sorted(strange))}")
        if absent := [p.name for p in accepted if p.default is p.empty and p.kind is p.POSITIONAL_OR_KEYWORD and p.name not in step.params]:
            raise SpecError(f"{step.name} needs {', '.join(absent)}")
        known.add(step.name)
    if spec.output not in known:
        raise SpecError(f"unknown output {spec.output}")


def run(spec: QuerySpec, layers: dict[str, DataFrame]) -> DataFrame:
    """The output layer; only operations that it depends on are lowered."""
    validate(spec, set(layers))
    steps = {s.name: s for s in spec.operations}
    made = dict(layers)

    def layer(name: str) -> DataFrame:
        if name not in made:
            step = steps[name]
            function, roles = OPERATIONS[step.op]
            given = [step.inputs[r] for r in roles]
            more = {r: layer(x) for r, x in step.inputs.items() if r not in roles}  # layers that a parameter takes
            made[name] = function(*[layer(x) if isinstance(x, str) else [layer(y) for y in x] for x in given], **more, **step.params)
        return made[name]

    return layer(spec.output)
