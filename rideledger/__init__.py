"""Invoice-control analytics for contracted passenger transport, as Spark DataFrame operators."""
