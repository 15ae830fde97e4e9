"""biotally: table-scale assay, sequence and pharmacology analytics on PySpark."""
