"""Query catalogue: modules with QUERIES and SQL."""

CATALOGUE = ["loomgraph.plans.reference_queries", "loomgraph.plans.retrieval", "loomgraph.plans.graph_queries", "loomgraph.plans.ingest_queries"]
FLAGSHIP = "rrf_fusion"
