"""DataFrame to DataFrame operators; batch unless a docstring says otherwise."""
