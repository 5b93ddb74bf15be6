"""DataFrame-to-DataFrame operators; time is always a parameter."""
