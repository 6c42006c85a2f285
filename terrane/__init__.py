"""Environmental-signature analytics as Spark DataFrame plans."""
