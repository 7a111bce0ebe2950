"""graphmill: code-graph, retrieval and telemetry analytics on Spark DataFrames."""
