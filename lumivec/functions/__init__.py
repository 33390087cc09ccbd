"""Column functions: text normalisation and tokenisation, all inside Spark's expressions."""
