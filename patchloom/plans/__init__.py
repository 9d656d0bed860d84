"""Whole plans made of the operators: the analysis, its reports and the registered queries."""
