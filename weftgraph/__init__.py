"""weftgraph: a knowledge-graph analytics engine on the Spark DataFrame API.

The package holds functions from DataFrames to DataFrames.  Nothing in it but
``weftgraph.llm`` itself imports ``weftgraph.llm``; that subpackage may be deleted.
"""

__version__ = "0.1.0"
