"""operators of terrakite."""
