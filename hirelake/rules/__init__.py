"""Rule data: word lists, rates and patterns the operators read."""
