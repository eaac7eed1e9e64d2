"""foldspan: leak-free features, ensembles and evaluation as Spark DataFrame operators."""
