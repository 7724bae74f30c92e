"""Operators of a training-data pipeline: tokens, quality, dedup, extraction and mixing.

Nothing outside this subpackage imports it.  Common conventions:

* a *word* is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``;
* a null text counts as the empty text (an operator that differs says so);
* operators select the columns they need by name, so extra columns with clashing names do no harm;
* intermediate tables go to the shared folder named by ``spark.checkpoint.dir`` (see ``scratch``).
"""
