"""strata: arrangements, routes and quality of drawings for tables of graphs, as Spark plans."""
