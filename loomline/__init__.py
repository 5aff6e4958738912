"""loomline: branching message-log analytics expressed as Spark DataFrame transformations."""
