"""sources of terrakite."""
