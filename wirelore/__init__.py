"""Network-forensics analytics expressed as Spark DataFrame transformations."""
