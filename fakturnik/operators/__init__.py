"""DataFrame operators: profiling, history, layout, tables, decoding, images."""
