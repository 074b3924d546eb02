"""Where changes and documents come from and go to."""
