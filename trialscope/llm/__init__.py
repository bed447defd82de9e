"""Training-data operators: dedup, classifiers, packing, tokenising, archives, licences, chat."""
