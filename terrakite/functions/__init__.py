"""functions of terrakite."""
