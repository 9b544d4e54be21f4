"""assaylake: sparse observation x feature analytics as Spark DataFrame plans.

Sub-packages
------------
functions   column expressions (cleaning rules, special functions, ranks)
sources     readers, writers and constant tables
operators   DataFrame -> DataFrame operators
plans       helpers that shape physical plans (scratch tables, joins, fixpoints)
streaming   incremental variants of the fragment operators
queries     the registered queries and the SQL they are compared with
"""

from assaylake.model import Assay, LayerSpec, Pct

__all__ = ["Assay", "LayerSpec", "Pct"]
