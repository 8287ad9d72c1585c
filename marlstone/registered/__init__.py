"""Registered queries by area, each with its DuckDB SQL."""
