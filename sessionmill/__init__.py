"""Analytics over logs of AI coding assistants, written as Spark DataFrame operators."""
