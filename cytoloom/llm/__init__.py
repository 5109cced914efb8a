"""Operations of a training-data pipeline: classifiers, packing, near-duplicates, archives, mixing, scans, extraction, search."""
