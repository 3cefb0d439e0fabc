"""Query plans: bindings of the test tables to operator inputs
(``bindings``), their DuckDB twins (``oracle``), compositions
(``workflows``) and the registered queries (``q_*`` modules, collected by
``registry.load_all``)."""
