"""Slide/tile analytics and corpus preparation as Spark DataFrame operators."""
