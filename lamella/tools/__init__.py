"""Jobs for spark-submit."""
