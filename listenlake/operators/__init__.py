"""DataFrame -> DataFrame operators; every one handles all users in one plan."""
