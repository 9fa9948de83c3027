"""Part of quillmark; see the README for what lives here."""
