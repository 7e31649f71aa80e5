"""streaming of terrakite."""
