"""Operators for preparing training text, each in a module of its own.

``suffix_dedup`` repeated passages, ``decontaminate`` benchmark overlap, ``url_filter`` address rules and
model, ``simhash`` near copies, ``pii`` personal data, ``quality`` language-model filter, ``warc`` archives
and their index, ``topk`` exact inner-product search, ``ctw`` byte-level scoring, ``packing`` windows of
tokens, ``pieces`` merge-type encoding, ``conversations`` repair of turns, ``spelling`` variants of words. ``queries`` registers one query per operator. Nothing outside this package imports it, except the
guarded import in ``__spark_entry__`` and ``corpus_pipeline``.
"""
