"""Readers and writers: driver tables, provider-shaped chats, stores, source code."""
