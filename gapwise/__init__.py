"""Incomplete-data analytics on Spark DataFrames.

Given a table with missing cells, a label and a model class, the package
profiles the gaps, prepares the data and decides with distributed aggregates
whether imputation is needed at all.  Conventions used everywhere:

* NULL is the only missing marker (NaN is normalised away when reading);
* rows carry an explicit key column, never a position;
* features and label are passed by name;
* every random choice is a function of ``md5(seed | key)``, so a lost task
  recomputes exactly the rows it produced before.
"""
