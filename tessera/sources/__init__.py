"""Where byte relations come from and go to: tables, generators and image files."""
