"""corpusloom: text-corpus curation, audit and evaluation as Spark DataFrame plans."""
