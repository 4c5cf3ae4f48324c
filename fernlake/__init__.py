"""Outline, graph, retrieval and trace analytics as Spark DataFrame operators."""
