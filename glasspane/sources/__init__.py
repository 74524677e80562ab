"""Readers and writers for the tables and file formats the engine works on."""
