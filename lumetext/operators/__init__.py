"""Operators on DataFrames: index, ranking, links, dictionary, snippets, crawl, evaluation."""
