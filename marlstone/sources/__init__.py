"""Where series and samples come from and where they are kept."""
