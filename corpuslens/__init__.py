"""Corpus analytics as Spark DataFrame transformations.

Every public function takes DataFrames (plus plain parameters) and returns a lazy DataFrame.
"""
