"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  Every operator takes
DataFrames, reads nothing but them, and keeps these rules unless its own
docstring says otherwise:

* a null text counts as an empty one;
* rows that agree in both document id and text are copies of one document and
  get the same result; a null id is a value like any other;
* an empty table gives an empty result with the full schema;
* columns an operator doesn't know are carried along or ignored, and an input
  column named like an output column is replaced by the output.
"""
