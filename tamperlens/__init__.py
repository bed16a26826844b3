"""tamperlens: screens model artifacts and the texts around them, as Spark jobs.

Artifacts, archive members, opcodes, header fields, dependencies, URLs and
weights are DataFrames; signatures are small rule tables; each detector is a
function from DataFrames to one fixed ``findings`` table.
"""

__version__ = "0.1.0"
