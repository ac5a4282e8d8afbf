"""All registered queries over the corpus tables, and the SQL that each is held against."""

from __future__ import annotations

from . import q_annotation, q_batches, q_captions, q_frames, q_motion, q_names, q_review, q_tables, q_topology, q_training, q_trees

_ALL = {**q_names.QUERIES, **q_tables.QUERIES, **q_frames.QUERIES, **q_training.QUERIES, **q_trees.QUERIES, **q_captions.QUERIES, **q_motion.QUERIES, **q_topology.QUERIES, **q_review.QUERIES, **q_annotation.QUERIES, **q_batches.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
