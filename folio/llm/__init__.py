"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Nothing else in the library imports this subpackage; ``__spark_entry__``
adds its queries when it can be imported. Conventions of every operator:

* it returns columns under its own names; an input column whose name
  clashes with one of them is replaced;
* null text counts as the empty text, unless its docstring says otherwise;
* an empty table gives an empty result.
"""
