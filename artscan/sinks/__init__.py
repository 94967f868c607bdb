"""Where results go: reports, logs, history, quarantine."""
