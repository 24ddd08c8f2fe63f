"""Table operators: ``df`` first, plain column names, lazy unless said otherwise."""
