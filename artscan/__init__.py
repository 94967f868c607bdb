"""artscan: archive, script and corpus scanning expressed as Spark DataFrames."""
