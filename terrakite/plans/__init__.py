"""plans of terrakite."""
