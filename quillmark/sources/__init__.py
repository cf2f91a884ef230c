"""quillmark.sources"""
