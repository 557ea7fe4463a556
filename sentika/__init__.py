"""Review analytics on Spark: clean, label, measure, model and report review text.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns; nothing is executed until the caller runs an action, except where a
docstring says otherwise (model fitting, reliable checkpoints, file sinks).
"""

from sentika.lexicons import Lexicon

__all__ = ["Lexicon"]
