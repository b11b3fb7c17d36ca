"""The library's registered queries over the standard tables, each with its DuckDB counterpart where SQL has one."""
