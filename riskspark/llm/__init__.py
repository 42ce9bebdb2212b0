"""Training-data operators: deduplication, filters, classifiers, search,
mixing and tokenising.  Nothing outside this subpackage imports it."""
