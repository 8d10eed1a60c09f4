"""Operators over fact relations: relations, graph, metrics, hygiene, integrity, snapshots, runtime."""
