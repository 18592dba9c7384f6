"""Column expressions: hashing, dates, text, geography. All run inside Spark's generated code."""

from .expressions import (cell_geohash, clamp, date_part, haversine, equirectangular, hash_bucket,
                          hash_rank, parse_timestamp, similarity, token_sort_key, word_tokens)

__all__ = ["cell_geohash", "clamp", "date_part", "haversine", "equirectangular", "hash_bucket",
           "hash_rank", "parse_timestamp", "similarity", "token_sort_key", "word_tokens"]
