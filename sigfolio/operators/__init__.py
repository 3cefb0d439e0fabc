"""DataFrame -> DataFrame operators: cleaning, joins (as-of, cache),
price windows, training sets, messages, evaluation, similarity, portfolio,
performance, the filing corpus job and the classifier plug-in."""
