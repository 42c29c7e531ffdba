"""DataFrame operators over messages, touches, vectors, graphs and snapshots."""
