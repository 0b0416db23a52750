"""waygraph: routing and network analysis on Spark DataFrames."""

import importlib
import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel by value: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The names for users, and where they are; a module is imported when one of its names is first used.
_API = {
    "Graph": "tables:Graph", "load": "sources.csv:read_graph_dir", "load_lines": "sources.csv:read_graph", "from_arrays": "sources.csv:from_rows",
    "load_transit": "sources.csv:read_transit", "load_transit_lines": "sources.csv:read_transit_lines", "algorithms": "operators.harness:algorithms", "register": "operators.harness:register", "route": "operators.harness:route",
    "race": "operators.harness:race", "verify": "operators.harness:verify", "default_endpoints": "operators.harness:default_endpoints",
    "AltIndex": "operators.index:Landmarks", "ContractionHierarchy": "operators.index:Contraction", "CustomizableCH": "operators.index:Hierarchy",
    "k_shortest_paths": "operators.paths:k_shortest", "path_cost": "operators.paths:path_costs", "reconstruct_path": "operators.paths:least_paths",
    "shortest_paths": "operators.trees:pair_paths", "greedy_paths": "operators.greedy:greedy_paths", "shortest_tree": "operators.trees:shortest_tree", "trace_back": "operators.trees:trace_back",
    "congestion_range": "operators.timedep:congestion_range", "congestion_tiers": "operators.timedep:congestion_tiers", "earliest_arrival": "operators.timedep:earliest_arrivals", "scan_departures": "operators.timedep:scan_departures",
    "bridges": "operators.analysis:bridges", "articulation_points": "operators.analysis:articulation_points", "components": "operators.analysis:components",
    "strongly_connected_components": "operators.analysis:strong_components", "betweenness_centrality": "operators.analysis:betweenness",
    "minimum_spanning_tree": "operators.analysis:spanning_tree", "max_flow": "operators.analysis:max_flow", "min_cut": "operators.analysis:min_cut",
    "isochrone": "operators.spatial:isochrone", "convex_hull": "operators.spatial:convex_hull", "nearest": "operators.spatial:k_nearest", "within": "operators.spatial:within",
    "directions": "operators.directions:build_directions", "filter_network": "operators.transit:filter_network", "rail_only": "operators.transit:rail_only",
    "combine": "operators.transit:combine", "coordinates": "sources.sinks:coordinates", "edge_list": "sources.sinks:edge_list", "publish": "surface:publish", "publish_places": "surface:publish_places", "follow_closures": "streaming.closures:follow_closures",
}
__all__ = sorted(_API)


def __getattr__(name: str):
    if name not in _API:
        raise AttributeError(name)
    module, attribute = _API[name].split(":")
    return getattr(importlib.import_module(f"{__name__}.{module}"), attribute)
