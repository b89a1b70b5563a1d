"""Gleaner: listings clean-up, publishing and labelling on PySpark."""
