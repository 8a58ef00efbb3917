"""gridloom: layout geometry, defect lists and training corpora as Spark jobs."""
