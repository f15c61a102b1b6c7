"""Small-area disease mapping as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame -> DataFrame``; see the
sub-packages ``sources``, ``functions``, ``operators`` and ``plans``.
"""
