"""thicket: cluster-support analytics over tables of any size, on Spark.

The package is organised by role: ``functions`` holds Column builders,
``operators`` the relational and numeric operators, ``sources`` readers and
writers, ``plans`` the end-to-end workflows and ``streaming`` the incremental
forms.  Nothing here starts a session; callers pass their own.
"""
