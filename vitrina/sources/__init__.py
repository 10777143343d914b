"""Readers and writers of the files the operators work on."""
