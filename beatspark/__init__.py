"""Spark jobs over beat-level physiological time series.

Every public function takes and returns DataFrames (or Columns); nothing here runs an action unless its
docstring says so.
"""
