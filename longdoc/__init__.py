"""longdoc: retrieval-augmented long-document dataset operators on Spark.

Every operator takes DataFrames and returns DataFrames; the heavy lifting is
ordinary Spark SQL (joins, aggregates, windows, higher-order array functions).
Arrow-batched Python is used only where a vectorised kernel is the natural
tool: the token-id lookup and decode, per-chunk term frequencies, the hashing
encoder, the per-tile dense top-k, the LCS of ROUGE-L/Lsum, and user-supplied
tokenizers, encoders and generators.
"""

from longdoc.constants import EOS, PAD, UNK  # noqa: F401

__version__ = "0.1.0"
