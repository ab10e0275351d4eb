"""Training-data operators: ten pipeline components over a ``documents`` table.

Nothing else in the library imports this subpackage.  Every module holds one operator with a general
interface; ``llm.queries`` derives the registered query results from them.
"""
