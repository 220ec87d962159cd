"""recordloom: document intelligence over large record collections, on Spark.

Operators are plain ``DataFrame -> DataFrame`` or ``Column -> Column`` functions; nothing here starts a
session or reads a path unless the caller asks for it.
"""

__version__ = "0.1.0"
