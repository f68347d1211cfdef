"""Progress, target and place analytics over item/find tables, as Spark jobs.

Every public function takes and returns DataFrames (or Columns) and is lazy:
nothing is collected, and each per-user question of the domain is answered for
all users at once.
"""
