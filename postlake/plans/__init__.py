"""Plans: the registered queries (``registry``), their DuckDB oracle SQL
(``oracle``) and the flat output shapes used for comparison (``flat``)."""
