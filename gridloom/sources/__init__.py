"""Where arrays come from and go to."""
