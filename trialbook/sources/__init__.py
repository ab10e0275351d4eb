"""Readers of a workspace's small files and directories, and writers of records."""
