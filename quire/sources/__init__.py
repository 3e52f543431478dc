"""Reading workspaces and files, versioned snapshots, Markdown reports."""
