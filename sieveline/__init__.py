"""A contact-data engine written as Spark DataFrame transformations."""
