"""Spark operators over tables of text boxes, predictions, scores, jobs and logs."""
