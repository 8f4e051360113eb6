"""strandline: tabular, sequence and genotype analytics as Spark DataFrame plans."""
