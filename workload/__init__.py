"""Checked queries: every operator applied to the fixture tables, with its SQL counterpart.

Each module offers ``QUERIES`` (name -> callable of session and folder) and ``ORACLE`` (name -> SQL).
"""
