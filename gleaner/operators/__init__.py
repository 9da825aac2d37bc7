"""Operators over inventories: every one takes DataFrames and returns one."""
