"""Session settings, materialisation and composed plans."""
