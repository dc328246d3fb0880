"""Chains of stages under one name."""
