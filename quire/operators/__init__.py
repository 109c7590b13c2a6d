"""DataFrame operators: segmentation, retrieval, ranking, context, evaluation, corpus upkeep."""
