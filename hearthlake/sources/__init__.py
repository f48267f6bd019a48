"""Readers that turn raw pages, feeds and files into typed rows."""
